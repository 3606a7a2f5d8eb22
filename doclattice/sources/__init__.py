"""Readers (``files``) and writers (``sinks``)."""
