"""Runnable jobs over the library; see each module's ``main``."""
