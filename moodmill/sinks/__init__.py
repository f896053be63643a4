"""Writers for the corpus, label tables, training sets and exports."""
