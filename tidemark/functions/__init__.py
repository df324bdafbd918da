"""Column functions: text, URLs, salaries, dates, schedules."""
