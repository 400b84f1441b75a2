"""tesserae.sinks: reports as text, JSON lines and exit codes."""
