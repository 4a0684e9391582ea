"""Whole queries: the engine facade and the registered catalogue."""
