"""Operators over points, windows and contigs."""
