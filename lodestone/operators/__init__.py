"""Part of lodestone: operators."""
