"""Core subpackage: functions."""
