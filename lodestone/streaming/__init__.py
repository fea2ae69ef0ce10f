"""Part of lodestone: streaming."""
