"""Readers and writers of rasters, manifests and artefacts."""
