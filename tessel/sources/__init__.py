"""Mesh sources and sinks: templates, files, quantisation, model selection."""
