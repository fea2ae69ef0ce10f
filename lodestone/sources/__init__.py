"""Part of lodestone: sources."""
