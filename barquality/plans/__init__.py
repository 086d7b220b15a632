"""What callers use: store, reports, insights and the engine's front."""
