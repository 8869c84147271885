"""Operations of a training-data pipeline on text, pages, vectors and chats.

Nothing else in the package imports this subpackage.
"""
