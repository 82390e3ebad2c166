"""Statistical diagnostics for segments."""
