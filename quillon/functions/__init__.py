"""Column expressions over text: cleaning, glyphs, morphology, encodings."""
