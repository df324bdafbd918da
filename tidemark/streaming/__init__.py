"""Structured Streaming forms of the log and the tracker."""
