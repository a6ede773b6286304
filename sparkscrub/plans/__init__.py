"""Plans that several operators share: fused statistics and row order."""
