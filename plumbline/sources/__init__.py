"""Readers and writers of snapshots, features, splits, predictions and manifests."""
