"""Index builds, the snapshot store and searches."""
