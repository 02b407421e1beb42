"""Readers and writers of images and of the files made from them."""
