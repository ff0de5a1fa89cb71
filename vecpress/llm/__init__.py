"""Training-data operators: sharding, packing, language identification and the rest.

Nothing outside this folder imports it; deleting it leaves the vector engine intact.
"""
