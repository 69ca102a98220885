"""Session set-up and code shipping."""
