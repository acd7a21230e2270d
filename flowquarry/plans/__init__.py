"""Plan-level building blocks: materialising, size-checked joins, ranks, whole workflows."""
