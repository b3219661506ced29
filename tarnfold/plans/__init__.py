"""See the README for what lives here."""
