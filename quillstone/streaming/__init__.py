"""Streams: the same DataFrame functions over micro-batches; a finished stream gives the batch's rows."""
