"""Part of lockweave; see the package README."""
