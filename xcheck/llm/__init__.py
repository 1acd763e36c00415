"""Operators of a training-data pipeline over ``documents`` and ``pages``.

Nothing else in the library imports this subpackage. ``queries`` registers one
``opN_<name>`` query per operator; each operator module keeps its own general
``DataFrame -> DataFrame`` interface.
"""
