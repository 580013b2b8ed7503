"""Column functions: phases, boxes, guarded ratios, significance."""
