"""Operators for language-model training data.

Every module here stands alone: the rest of ``quillstone`` never imports this subpackage.
"""
