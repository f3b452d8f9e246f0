"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` registers them and ``oracles`` holds their SQL.
"""
