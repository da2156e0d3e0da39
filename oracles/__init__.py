"""Reference SQL for the check tool."""
