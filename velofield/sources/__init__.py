"""Where tables of frames, pairs, calibration points and logs come from, and where results go."""
