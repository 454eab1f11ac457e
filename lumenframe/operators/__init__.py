"""Set-based operators over voxel, instance, landmark and verdict tables."""
