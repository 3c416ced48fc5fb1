"""How plans are cut and sized: written tables in the shared folder, sizes of partitions and checked broadcasts."""
