"""Readers and writers: catalogues, tile stores, annotation packs, detections."""
