"""Operators that prepare text for the training of language models.

Each module holds one operator. All take a DataFrame of documents and the names of its id and text columns,
read nothing else of it, and leave every other column alone, so that extra columns never clash.
Ids are integers; a column of another type is refused by a TypeError. Helper columns take names that the table hasn't.
Tokens, hashes and offsets come from ``text``; what a null id or a null, empty or very long text gives is
stated by each operator.
"""
