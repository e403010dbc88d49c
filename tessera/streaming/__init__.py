"""Part of Tessera: streaming."""
