"""Wavelet indexes over large symbol sequences, built on Spark DataFrames."""
