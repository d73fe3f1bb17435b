"""Table operators: detection, overlap resolution, masking, guards, bodies, metrics, feed, keys."""
