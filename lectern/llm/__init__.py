"""Operators for training data: text repair, splitting, packing, counting, matching, mixing and masking."""
