"""Part of folioflow; see README."""
