"""Where bars come from: vendor files, frames, generators, and the driver's tables."""
