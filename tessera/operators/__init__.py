"""Part of Tessera: operators."""
