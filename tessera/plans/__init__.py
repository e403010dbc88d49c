"""Part of Tessera: plans."""
