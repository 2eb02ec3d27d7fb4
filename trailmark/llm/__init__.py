"""Training-data operators: near-duplicates, private data, decontamination, archives, packing, quality, token files, licences."""
