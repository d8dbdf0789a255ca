"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; the registry in
``__spark_entry__.py`` adds its queries only where it can be imported.
"""
