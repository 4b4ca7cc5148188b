"""Scans, sinks and panel builders."""
