"""Schedules, politeness, definitions: what to run next, and how."""
