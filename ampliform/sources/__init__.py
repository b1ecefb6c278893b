"""FASTA, FASTQ and table files as DataFrames, and back."""
