"""Part of quernlex; see the README for what lives here."""
