"""Part of orbitframe; see README.md."""
