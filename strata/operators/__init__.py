"""Pure DataFrame operators over changelogs, runs and their metadata."""
