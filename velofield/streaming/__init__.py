"""Streams of frames: running means, pairs as their frames arrive, phase chains, windows over events."""
