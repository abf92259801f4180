"""The log as a stream: counts by window, and plug-ins as they come."""
