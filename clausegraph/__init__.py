"""Clause extraction, alias bridging, pair targeting and contradiction detection over normative documents, as DataFrame plans."""
