"""Part of lodestone: functions."""
