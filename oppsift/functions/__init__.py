"""Part of oppsift."""
