"""Analytics over corpora of norms, chats and case files, as DataFrame plans."""

__version__ = "0.1.0"
