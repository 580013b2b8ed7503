"""Where light curves and frames come from."""
