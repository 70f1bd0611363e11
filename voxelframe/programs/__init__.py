"""Command-line programs: ``python -m voxelframe.programs.mask_cosmics``, ``python -m voxelframe.programs.turn_square``."""
