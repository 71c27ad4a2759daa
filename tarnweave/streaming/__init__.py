"""Structured Streaming queries; each equals its batch counterpart once the input has ended."""
