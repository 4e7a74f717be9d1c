"""Scalar functions: tokens, stems, addresses, sizes."""
