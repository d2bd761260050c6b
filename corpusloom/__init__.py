"""corpusloom: DataFrame operators for building, cleaning, searching and scoring text corpora."""
