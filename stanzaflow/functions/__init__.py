"""Part of stanzaflow."""
