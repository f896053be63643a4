"""Column expressions: text cleaning, hashing, scoring, aspect mining, time."""
