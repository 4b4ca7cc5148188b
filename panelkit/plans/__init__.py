"""Plan shapes that keep ordered work spread over many tasks."""
