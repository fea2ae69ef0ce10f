"""Part of lodestone: plans."""
