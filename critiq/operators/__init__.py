"""Table operators: data frames in, data frames out."""
