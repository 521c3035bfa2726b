"""Multi-step plans: manifests, chunking, ordered assembly and resumable stage tables."""
