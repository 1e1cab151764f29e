"""Lodestone: functions."""
