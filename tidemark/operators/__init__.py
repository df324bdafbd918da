"""DataFrame operators on postings, runs, events and pages."""
