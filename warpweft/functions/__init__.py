"""Part of warpweft."""
