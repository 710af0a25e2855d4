"""Reading and writing trajectories: tables, CSV recordings, replaceable result tables."""
