"""Readers for result files, event logs, label lists, inventories, regions and audio."""
