"""Part of tracelake; see the README for what lives where."""
