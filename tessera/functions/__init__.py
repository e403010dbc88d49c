"""Part of Tessera: functions."""
