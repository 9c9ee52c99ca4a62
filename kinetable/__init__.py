"""Frame-sequence analytics on Spark: clouds, meshes, voxels, joints and skeletons as long tables."""
