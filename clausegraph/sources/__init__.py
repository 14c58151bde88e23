"""Readers and writers: text corpora, manifests, ground truth, reports, queues, history, keyed snapshots."""
