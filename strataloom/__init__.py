"""Strataloom: DataFrame operators that turn document collections into verified, versioned facts."""
