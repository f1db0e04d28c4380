"""Guarded similarity analytics as DataFrame programs."""
