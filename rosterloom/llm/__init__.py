"""Operators for preparing training text: one module per operator.

Nothing outside this folder (but for the guarded import in the driver contract)
imports it.  ``queries`` holds the registered queries and their check SQL.
"""
