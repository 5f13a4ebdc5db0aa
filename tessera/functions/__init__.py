"""Part of the tessera engine; see the README for what lives here."""
